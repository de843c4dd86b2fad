"""Sentences no model is trained on, with what must be found in them between marks.

``<n:...>`` name, ``<p:...>`` phone, ``<e:...>`` email, ``<i:...>`` identity number,
``<a:...>`` address.
"""

import re

PERSONAL = """
Nhờ có <n:Phạm Gia Bảo> mà chuyến đi suôn sẻ.
Xin cảm ơn <n:Phạm Gia Bảo> và gia đình.
Chị <n:Võ Hoài Thương> bán bánh xèo ở đầu chợ, quán mở từ 6 giờ.
Mình đi cùng bạn <n:Đinh Nhật Hạ>, hai đứa ngủ nhà sàn.
Bác <n:Lương Văn Tốt> chèo đò đã ba mươi năm.
Người phụ trách: <n:Trương Mỹ Lệ>, máy <p:0912 345 678>.
Quý khách cần hỗ trợ vui lòng gọi <p:0283 822 1234>.
Alo <p:+84 90 123 45 67> gặp em <n:Tiêu Ngọc Trâm> nha.
Số điện thoại liên hệ là <p:0987.654.321> (giờ hành chính).
Nhắn Zalo cho <n:Kiều Minh Trí> theo <p:0345-678-912>.
Mời gửi phản hồi tới <e:ban.bientap@dulichvn.com.vn>.
Hộp thư của mình: <e:hai_dang99@gmail.com>, ai có ảnh thì gửi nhé.
Thư xin gửi <e:lienhe (at) homestaysapa (dot) vn>.
Anh <n:Ngô Quang Hiển>, CCCD <i:079201004512>, đã trả phòng.
Khách xuất trình căn cước số <i:001098765432> khi nhận vé.
Chứng minh nhân dân <i:271234567> bị mờ số.
Hộ chiếu <i:C1234567> còn hạn sáu tháng.
Passport number <i:B7654321>, valid until May.
Nhà nghỉ ở <a:27 Trần Phú, Nha Trang> nhìn ra biển.
Mình trọ tại <a:15 đường Lê Lợi, phường Bến Nghé, quận 1>.
Quán cũ ở <a:48/3 ngõ 12 phố Hàng Bông, Hà Nội> đã đóng.
Ship giúp em tới <a:102 Nguyễn Trãi, phường 3, quận 5, TP. Hồ Chí Minh>.
Bà ngoại tôi sống tại <a:6 thôn Đông Hòa, xã Tân Mỹ, huyện Hòa Vang>.
The hostel is run by <n:Michael Thompson>, who speaks some Vietnamese.
We booked through <n:Pierre Lefebvre>, a friend of the owner.
<n:Marie Durand> recommended the night train.
Our captain, <n:Gregory Hughes>, kept everyone laughing.
Ask at the desk for <n:Élodie Bonnet>.
<n:Tadeusz Malinowski> wrote: the stairs are steep.
Review by <n:Oluwaseun Adeyemi>, two nights in June.
You can call <n:Beatriz Ferreira> on <p:+351 912 345 678>.
Reach the office at <p:(024) 3825 1234> before noon.
Questions? Write to <e:info@sunrise-boats.co.uk>.
Mr. <n:Kwame Boateng> lost a passport, <i:K2468135>, near the pier.
She stays at <a:12 Hoang Dieu Street, Hai Chau Ward, Da Nang>.
<n:Phan Thị Diệu Hiền> (<e:dieuhien.phan@outlook.com>) hỏi giá phòng đôi.
Ký tên
<n:Hoàng Đình Khải>
<p:0903 112 233>
Hôm đó <n:Lê Thị Như Ý> chụp cho cả nhóm.
Tài xế <n:Đặng Phước Lành> lái rất êm.
Vé đứng tên <n:Bùi Tiến Dũng>, ghế 12B.
"""

OTHER = """
Phố Lý Thường Kiệt đông nghẹt vào giờ tan tầm.
Rẽ vào đường Trần Phú rồi đi thẳng ra biển.
Bệnh viện Nguyễn Huệ nằm sau chợ.
Hà Nội tháng này se lạnh, Đà Lạt thì mưa.
Công ty Vũ Gia Phát tài trợ áo mưa.
Trường Lê Quý Đôn nghỉ hè từ tháng 6.
Đền Trần Hưng Đạo mở cửa tự do.
Mã vận đơn 0912345678 đang ở kho.
Hóa đơn 079201004512 xuất ngày 3/4.
Số sê-ri 0987654321 in dưới đáy máy.
Lô B1234567 hết hạn cuối năm.
Tọa độ 16.0544, 108.2022 ở giữa bãi.
Gọi 115 nếu có người ngất.
Theo dõi @phuot.bui trên mạng để xem ảnh.
Giá 1.250.000 đồng một đêm, thêm 2@150k cho trẻ em.
The Blue Lotus Cafe on Hai Ba Trung Street closes early.
Order 0345678912 has left the warehouse.
Mount Fansipan and West Lake are both worth a day.
Bãi Dài và Hòn Tre vắng khách ngày thường.
Chợ Bến Thành bán đủ thứ, mặc cả thoải mái.
"""

KINDS = {"n": "name", "p": "phone", "e": "email", "i": "id_number", "a": "address"}


def cases():
    """(text, right) of every sentence."""
    out = []
    for block in (PERSONAL, OTHER):
        for line in re.sub(r"Ký tên\n(.*)\n", r"Ký tên\\\1\\", block).strip().split("\n"):
            text, right, at = "", set(), 0
            for m in re.finditer(r"<(\w):([^<>]*)>", line):
                text += line[at : m.start()]
                right.add((KINDS[m.group(1)], m.group(2)))
                text += m.group(2)
                at = m.end()
            out.append(((text + line[at:]).replace("\\", "\n"), right))
    return out
